"""Operators on samples, prototypes, bases and client state: functions of DataFrames."""
