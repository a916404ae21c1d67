"""Operators by theme: rules, matching, spatial, aggregates, ordering, features, modelling, serving, pixels, usage."""
