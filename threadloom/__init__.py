"""Threadloom: conversation, tool-log and corpus processing on PySpark."""
