"""Readers of reports, policies, snapshots and source trees."""
