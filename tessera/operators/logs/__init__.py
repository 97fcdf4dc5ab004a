"""Typed fields with exact positions out of heterogeneous access-log lines: five grammars, one pass, no shuffle."""
