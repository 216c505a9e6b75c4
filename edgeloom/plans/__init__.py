"""Connected components: local kernel, contraction strategies, sampling policies and the driver loop."""
