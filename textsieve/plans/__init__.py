"""End-to-end jobs made of the operators. These write tables and therefore run Spark jobs."""
