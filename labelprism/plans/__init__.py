"""End-to-end plans (the reference's three workflows) and the registered queries."""
