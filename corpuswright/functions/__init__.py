"""Part of the corpus engine; see the modules."""
