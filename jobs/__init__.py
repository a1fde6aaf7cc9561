"""Jobs that run by themselves, from the command line or a scheduler; `queries.py` registers them."""
