"""DataFrame -> DataFrame operators: joins, metrics, order-dependent logic, figures and context."""
