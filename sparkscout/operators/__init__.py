"""Distributed operators: preparation, statistics, miners, what-if, charts."""
