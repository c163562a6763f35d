"""DataFrame operators for catalogues, series, transects, rasters and validation."""
