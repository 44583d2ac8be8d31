"""Relational operators over temporal graphs. A matrix is a relation of its non-zero entries."""
