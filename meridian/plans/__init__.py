"""Requests and what composes them."""
