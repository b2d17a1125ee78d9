"""End-to-end jobs (``pipelines``), the registered query catalog and its SQL twins."""
