"""Registered plans: each query builds a lazy DataFrame from the test
tables (``catalog``); ``oracle`` holds independent SQL for the check."""
