"""A fact table derived from the shared test data, and its SQL twin."""
