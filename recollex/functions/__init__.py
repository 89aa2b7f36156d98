"""Part of Recollex; see the README for the layout."""
