"""Plan shapes shared by the operators, and the registered queries."""
