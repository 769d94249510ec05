"""strandline: episode analytics and training-data preparation as composable Spark DataFrame functions."""
