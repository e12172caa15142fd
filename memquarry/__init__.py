"""memquarry: media-recall search and library jobs as PySpark DataFrame plans."""
