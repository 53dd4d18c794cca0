"""Standard tables seen as screens, the registered queries and the analysis pipeline."""
