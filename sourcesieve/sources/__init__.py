"""Where sources come from: directories, files in any store Spark reads, and columns of tables."""
