"""Plans: settings, voices, the command line, and the registered queries."""
