"""Plans that run over several rounds, and reports on them."""
