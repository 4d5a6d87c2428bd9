"""webdistill: turn tables of raw web pages into clean, queryable content on Spark."""
