"""Where the store tables come from."""
