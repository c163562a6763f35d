"""Shoreline mapping and shoreline-change analysis as composable Spark DataFrame operators."""
