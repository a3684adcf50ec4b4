"""Strategy configuration, block compiler and plan composition."""
