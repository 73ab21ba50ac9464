"""Whole questions: the engine over stored profiles, and the same operators over plain tables."""
