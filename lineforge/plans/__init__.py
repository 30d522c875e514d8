"""The silver and gold models, the quality suite, the delivery model and the daily job."""
