"""pointloom: a PySpark-native analytics engine for point clouds, meshes and rasters."""
