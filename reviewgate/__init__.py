"""Review compliance on Spark: moderation, audit log, lookups, reports and
streaming monitoring over whole tables of product reviews."""

__version__ = "0.1.0"
