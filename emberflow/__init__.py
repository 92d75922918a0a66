"""emberflow: program-effect analytics and corpus operators as Spark jobs."""
