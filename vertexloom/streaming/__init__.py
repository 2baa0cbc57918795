"""Graph statistics over edge streams."""
