"""The usual chains of operators, from raw signals to fleet results."""
