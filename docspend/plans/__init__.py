"""All registered queries of the engine."""
