"""Query plans composed of operators: reports, renderers, the registered queries."""
