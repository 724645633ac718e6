"""Registered queries by section; each module has ``QUERIES``: name -> (function of Inputs, SQL or None)."""
