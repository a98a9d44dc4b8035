"""Compositions: repository profiles, review by a model, whole scans."""
