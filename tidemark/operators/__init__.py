"""Operators over change logs: frames of key columns, commit_ts, op (I, U or D) and payload columns."""
