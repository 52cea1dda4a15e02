"""Readers and writers for transactions, reports, attributions, incidents and metric logs."""
