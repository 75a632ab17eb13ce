"""Set-based operators over the engine's tables."""
