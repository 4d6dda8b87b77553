"""The functions of the engine."""
