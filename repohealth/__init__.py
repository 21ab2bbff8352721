"""repohealth: codebase-health analytics for many repositories, as Spark jobs."""
