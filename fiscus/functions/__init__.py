"""Column functions shared by sources and operators."""
