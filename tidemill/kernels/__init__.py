"""Dense numeric kernels on numpy arrays. Nothing here knows Spark; ``tidemill.operators.arrow`` applies them."""
