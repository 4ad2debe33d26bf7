"""Training-data operators: packing, language ID, de-duplication, scoring, sharding, archives."""
