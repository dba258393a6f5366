"""Runnable jobs over text tables; each module has a command line and a configuration file beside it."""
