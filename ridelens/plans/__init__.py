"""Tables materialised between stages, and the registered queries."""
