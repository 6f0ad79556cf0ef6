"""Screening-record analytics on Spark."""
