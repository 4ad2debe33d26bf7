"""Components, block pairs and groups, as the operators of this subpackage use them."""

from lumenfold.operators.groups import block_pairs, connected_components, forest, hot_keys, join_facts, map_groups

__all__ = ["block_pairs", "connected_components", "forest", "hot_keys", "join_facts", "map_groups"]
