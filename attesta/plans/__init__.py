"""Physical patterns shared by the operators.

Every pattern here exists for one reason: a single key may hold a large share of
all rows, so no operator may gather one key in one task.
"""
