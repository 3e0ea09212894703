"""Table profiling, cleaning, feature engineering and modelling as Spark jobs."""
