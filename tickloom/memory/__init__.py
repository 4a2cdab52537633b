"""Memory store of agents: records, ranking, context assembly, prompt cache and eviction, as DataFrame plans."""
