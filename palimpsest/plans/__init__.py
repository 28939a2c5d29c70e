"""Plans built on the driver: scopes as boolean columns."""
