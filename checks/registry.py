"""All registered queries, in the order of the build."""

from checks import customers, growth, jobs, orders, promotion, retention, scalars, workbooks

CHECKS = [*orders.CHECKS, *customers.CHECKS, *promotion.CHECKS, *scalars.CHECKS, *jobs.CHECKS, *growth.CHECKS, *retention.CHECKS, *workbooks.CHECKS]
