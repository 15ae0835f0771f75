"""Prosegrain: corpus linguistics and prose quality analytics on PySpark."""
