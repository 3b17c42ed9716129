"""readflow: Spark jobs for reading-text pipelines (ingest, admission, segmentation, planning, activity)."""
