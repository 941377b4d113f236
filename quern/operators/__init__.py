"""Table operators of the interview domain."""
