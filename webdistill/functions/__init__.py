"""Pure functions over one page: they import no Spark, so workers load them cheaply and tests run them alone."""
