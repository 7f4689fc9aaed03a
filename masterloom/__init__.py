"""Record mastering on Spark: two sources in, one attributed master out."""
