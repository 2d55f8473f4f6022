"""DataFrame operators over declared column roles."""
