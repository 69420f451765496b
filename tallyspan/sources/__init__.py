"""Readers that turn trees, tool output and logs into tables; nothing reads a file on the driver."""
