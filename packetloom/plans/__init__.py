"""Whole plans: normalisation, all detections over an event table, the read API, driver queries."""
