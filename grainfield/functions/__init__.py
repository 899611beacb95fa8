"""Part of grainfield; see the modules."""
