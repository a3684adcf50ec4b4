"""Indicator, strategy, factor and portfolio operators."""
