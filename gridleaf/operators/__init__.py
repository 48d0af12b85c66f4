"""DataFrame operators: grids, rasters, spatial joins, detection, recognised text."""
