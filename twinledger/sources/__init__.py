"""Readers and writers. Readers are lazy; where a format must be looked at first, the look is bounded."""
