"""Forecasters that fit every series in one distributed job."""
