"""Part of scriptorium; see the modules."""
