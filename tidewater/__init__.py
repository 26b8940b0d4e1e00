"""Tidewater: analytics and corpus operators written for Spark's DataFrame API."""
