"""Training-data pipeline operators: ten DataFrame -> DataFrame operators and their queries."""
