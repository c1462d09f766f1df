"""The stateful operators on streams."""
