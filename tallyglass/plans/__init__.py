"""Whole analyses: operators put together for one subject, or for a whole folder of tables."""
