"""Query plans composed of the operators, with their SQL equivalents."""
