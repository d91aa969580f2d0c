"""Part of the latticework engine."""
