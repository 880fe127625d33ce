"""Ready-made queries over the star-schema tables, each with SQL for an independent check."""
