"""Landed payloads, the store and the request manifest."""
