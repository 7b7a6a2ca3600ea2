"""Part of helixmill; see the README for the map of modules."""
