"""The same operators over unbounded streams."""
