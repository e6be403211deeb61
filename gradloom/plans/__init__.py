"""Join strategies, lineage control, objectives and optimizers."""
